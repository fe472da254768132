"""Hosts that are wanted and that are not, written by hand; their words train the url filter (6)."""

WANTED = """
dailynews worldnews localnews newsarchive nationalreview thetimes eveningpost morningherald cityguardian newspress pressrelease radionews weatherforecast
cityweather sportsnews footballscores baseballleague basketballteam hockeyclub tennisworld cyclingteam runningclub racetrack trackandfield olympicgames chessclub
sciencemagazine sciencelibrary universitypress stateuniversity collegeofart medicalschool lawschool highschool schooldistrict publiclibrary digitallibrary researchinstitute
researcharticle openjournal physicsreview mathworld chemistrylab biologyonline geologysurvey astronomypictures spaceagency climatecenter earthobservatory oceanresearch
historymuseum artmuseum cityhistorymuseum nationalgallery photogallery musicschool symphonyorchestra operahouse moviereviews filmfestival filmarchive theatercompany bookreviews
bookshop bookstore usedbooks poetryfoundation writersguild freebooks literaryreview dictionary encyclopedia wikiguide openwiki freeencyclopedia languagelearning learnenglish
onlinecourses freecourses coursecatalog adulteducation adultlearning teachersresource kidslearning childrenshospital parentingguide familyhealth healthreview healthservice
hospitalguide doctorsoffice nursingschool cancerresearch heartfoundation mentalhealth dentalcare eyecare pharmacyschool sexeducation drugsafety foodsafety nutritionfacts
foodblog recipebox cookingschool bakingblog winereview coffeehouse teahouse restaurantguide farmersmarket organicfarm dairyfarm familyfarm farmbureau gardencenter
gardendesign houseplants homeimprovement homedesign interiordesign architecturereview buildingcode realestate citycouncil citygovernment countyclerk statepark nationalpark
publichealth publicworks taxoffice courtrecords votersguide electionresults parliament senate embassy immigrationservice laborunion charityfund redcross foodbank animalshelter
petcare doglovers catcare birdwatching wildlifefund forestservice rivertrust mountainclub hikingtrails campingguide travelblog travelguide cityguide hotelreviews airlineinfo
airporttravel trainschedule busroutes trafficreport carreviews autorepair motorcycleclub bicycleshop boatclub craftfair knittingpatterns quilting woodworking paintingclass
photoblog photographyforum camerareview webcamweather musicblog musicreview jazzfestival guitarlessons pianolessons videotutorials videogamereview boardgames gamedesign
gamestudies computerhistory opensource opensourceproject sourcecode codedocs apidocs pythonprogramming softwarefoundation freesoftware downloadcenter linuxforum database datascience
statisticsoffice machinelearning securityblog networkadmin techreview technews mobilephone hardwarereview electronicsproject engineeringsociety standardsbody patentoffice
businessreview businessnews financialtimes economicsblog centralbank savingsbank creditunion studentloans stockmarket smallbusiness jobsearch careerguide insuranceguide
consumerreports marketresearch marketingblog seobasics adstandards shoponline giftshop toystore shoestore furniturestore clothingshop officesupply hardwarestore
mailinglist helpforum supportforum userguide projectteam teamlab labnotes blogarchive personalblog mypage homepage sitemap linklist weblinks winterworld
weddingplanner datingthepast churchhistory religionstudies philosophyforum psychologytoday sociologyjournal anthropology archaeology genealogy oldmaps mapservice
bestpractices bestbooks dealershipguide lotterycommission gamblinghelp pokerhistory cryptography escortvessel hackspace spamfilter pillbugs adultliteracy clickartdesign
newsblog articleindex blogpost postarchive pageindex greenenergy solarpower windfarm waterworks fireservice policeacademy veteransaffairs navymuseum aviationhistory railwaymuseum
onlinelibrary newsonline shoponlinetoday onlineshop onlinestore onlineschool onlinemaps onlinetutor biologyonline freesoftwarefoundation freelibrary freemusicarchive freefonts freetextbooks
weblinks linkdirectory usefullinks webdesign webhosting webdeveloper website webmail webarchive softwaredownload downloads downloadmanager downloaddocs livemusic livescores livenews liveweather
hotsprings hotelguide bestrestaurants besttravel bestpracticeguide buylocal buyersguide cheapflights cheaptravel discountbooks winterolympics winners prizewinners nobelprize bookprize
trackcycling trackyourorder packagetracking clickhelp clickanddrag trafficsafety traffic roadtraffic escortsquadron touristservice weatherservice postalservice customerservice bookclub
youthclub sportsclub filmclub gardenclub healthclub serviceclub adultcare adulteducationcenter adultliteracyproject sexandgender sexeducationforteens datingfossils radiocarbondating
advertisingstandards adcouncil spamfilters spamprevention antispam seoguide cashflow creditcardhelp mortgageloans homeloans carloan librarycards postcards greetingcards cardgames
pokemon serialnovel keyboards passwordmanager movies moviedatabase videos videolibrary picturebooks pictures girlscouts girlsschool boysclub hotsauce chatforum livechat massageschool
team teams people community village town region country island beach lake valley bridge castle church temple garden flower tree animal bird fish horse family house kitchen bread cheese coffee
energy engine machine robot satellite planet star physics chemistry biology medicine doctor nurse patient student teacher class lesson exam college campus academy journal editor author writer poem
story novel letter document report record archive data table chart map atlas calendar event festival concert dance theater painting sculpture design fashion fabric wood metal stone glass
"""
UNWANTED = """
porn freeporn pornvideos porntube hotporn pornpics gayporn pornstars sex sexcam freesex sexvideos sexchat livesex sexshop sextoys xxx xxxvideos xxxmovies freexxx
adult adults adultmovies adultsite adultsex adultx adultcam adultvideos adultchat adultdating adulttube nude nudecam nudepics nudegirls naked nakedgirls nakedpics erotic erotica eroticmassage hentai fetish fetishcam bdsm
milf milfcam slut sluts horny hornygirls hotgirls livegirls camgirls cams webcamsex escort escorts escortgirls escortagency escortsite escortservice cityescorts hookup hookups hookuptonight swingers
dating datingtonight singlesdating casualdating lesbiancam boobs tits bigtits pussy anal blowjob fuck fuckbook playboy stripper stripclub lingeriesex onlyfansleaks
casino casinos casinowin onlinecasino casinobonus bestcasino freecasino casinobets livecasino poker onlinepoker pokerbonus freepoker pokerroom slots freeslots onlineslots slotmachine
bet bets freebets betonline sportsbet sportsbets betting sportsbetting bettingtips bettingodds bookmaker bookmakers gambling onlinegambling gamblingsite gamble jackpot megajackpot roulette
blackjack baccarat bingo bingobonus lottery lotterywinner lottowinner winprize prizewinner freeprize winbig winmoney sweepstakes
viagra buyviagra cheapviagra genericviagra cialis buycialis levitra pills cheappills dietpills sexpills onlinepharmacy cheappharmacy discountpharmacy pharmacydiscount
xanax valium tramadol oxycontin ambien phentermine steroids buysteroids weightloss fatburner enlargement maleenhancement miraclecure
replica replicas replicawatches fakewatches fakerolex fakeid fakepassport fakedocuments counterfeit knockoff knockoffs cheapreplica replicahandbags cheapdeals cheaphandbags
payday paydayloan paydayloans cashadvance fastcash quickcash easymoney makemoneyfast getrichquick earncash instantloan instantloans badcredit badcreditloan creditrepair debtrelief
cryptobonus cryptowin freecrypto bitcoindoubler freebitcoin bitcoinwin cryptopump ponzi forexsignals forexprofit binaryoptions pyramidscheme
spam spamfarm spamlinks spamclicks spambot spamfarmads linkfarm clickfarm clickbait clickfraud buyclicks buytraffic buyfollowers buylikes trafficbot adstrack adtrack adserver
ads popads popupads freeads adclick adclicks adtracker adsclick tracker seolinks buylinks seospam backlinks paidlinks doorway scraper
hack hacks hacktools passwordhack hacker cheats gamehacks crack cracks cracked crackedsoftware warez freewarez warezdownload keygen keygens serialkeys torrent torrents moviestorrent torrentdownload
pirated piracy freemoviesonline nulled cracksoftware phishing malware spyware trojan ransomware botnet exploitkit stolencards carding carders leakedpasswords
"""
